"""Fixed parameters of the registered queries (clocks of the fixture ingests)."""

AS_OF = "2002-01-01 00:00:00"          # ingest clock for the orders-derived batch
EVENTS_AS_OF = "2024-02-01 00:00:00"   # ingest clock for the events-derived batch
