"""storelens streaming."""
