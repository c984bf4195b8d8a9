"""Settings: what is given on the command line, else what the file says, else the default."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass
class Settings:
    """Folders, the model, and the defaults of a search."""

    root: str = "knowledge"
    kb: str = "default"
    provider: str = "mock"
    url: str = "http://localhost:11434"
    model: str = ""
    form: str = "ollama"
    embed_url: str = ""
    embed_model: str = ""
    embed_form: str = "ollama"
    client: str = "plain"
    mode: str = "hybrid"
    top_k: int = 5


def load(path: str | None) -> dict:
    """What a YAML or JSON file sets; unknown keys and a missing file are no error."""
    import json
    from pathlib import Path

    if not path or not Path(path).exists():
        return {}
    text = Path(path).read_text()
    try:
        told = json.loads(text)
    except ValueError:
        import yaml

        told = yaml.safe_load(text)
    return told if isinstance(told, dict) else {}


def merged(flags: dict, told: dict) -> Settings:
    out = asdict(Settings())
    for f in fields(Settings):
        for source in (told, flags):
            if source.get(f.name) is not None:
                out[f.name] = type(out[f.name])(source[f.name])
    return Settings(**out)
