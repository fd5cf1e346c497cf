"""DuckDB SQL that states the expected result of every registered query."""
