"""Connected components, for the operators of this subpackage."""

from ..operators.components import components  # noqa: F401
