"""Column expressions: Column and literals in, Column out, all inside Catalyst."""
