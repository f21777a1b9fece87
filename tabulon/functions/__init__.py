"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from tabulon.functions.columns import (  # noqa: F401
    NUMERIC_TYPES,
    is_numeric,
    is_string,
    numeric_columns,
    quote,
    string_columns,
)
from tabulon.functions.topk import top_k_per_group  # noqa: F401
