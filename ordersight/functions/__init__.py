"""Column-expression helpers. Everything here returns ``Column`` objects (or SQL
text fragments for the oracle) so the work stays inside Catalyst / codegen."""
