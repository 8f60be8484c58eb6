"""DuckDB SQL of the queries that SQL can express on whole tables; the others are tested against brute force."""

ORACLES: dict[str, str] = {}
