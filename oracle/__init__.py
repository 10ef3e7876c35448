"""DuckDB SQL with the same meaning as the registered queries."""
