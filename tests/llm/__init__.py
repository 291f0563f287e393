"""A package, so that its modules may be named like those beside it."""
