"""Column functions and small numpy helpers."""
