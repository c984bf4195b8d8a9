"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from .chat import OP1_SQL, op1_chat
from .decontaminate import op9_decontaminate
from .divergence import OP11_SQL, op11_divergence
from .licenses import OP10_SQL, op10_license
from .linededup import op5_linededup
from .packing import op8_packing
from .pii import op3_pii
from .quality import op2_quality
from .reassembly import OP12_SQL, op12_reassembly
from .simhash import op6_simhash
from .topk import OP4_SQL, op4_topk
from .toxicity import op7_toxicity
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_topk": op4_topk,
    "op5_linededup": op5_linededup,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_license": op10_license,
    "op11_divergence": op11_divergence,
    "op12_reassembly": op12_reassembly,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": OP1_SQL,
    "op4_topk": OP4_SQL,
    "op10_license": OP10_SQL,
    "op11_divergence": OP11_SQL,
    "op12_reassembly": OP12_SQL,
    "op13_warc": OP13_SQL,
}
