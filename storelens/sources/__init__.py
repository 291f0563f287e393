"""storelens sources."""
