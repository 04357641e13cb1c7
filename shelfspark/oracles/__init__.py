"""DuckDB SQL that checks the operators."""
