"""tidemark: a read-only, multi-tenant time-series SQL engine on Spark."""
