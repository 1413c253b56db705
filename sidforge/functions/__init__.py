"""Column expressions; nothing here leaves the JVM.

Functions take column names (or SQL text) and return a column. The text behind
a function ``f`` is ``f_sql``: one parsed expression instead of a call into the
JVM per operator.
"""
