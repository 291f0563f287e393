"""storelens plans."""
