"""A knowledge base as an application: ingestion runs, the registry, the tools of agents, the command line."""
