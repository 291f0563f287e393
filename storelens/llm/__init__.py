"""Training-data operators over ``documents``, ``pages`` and ``benchmark``.

Nothing else in the library imports this subpackage.
"""
