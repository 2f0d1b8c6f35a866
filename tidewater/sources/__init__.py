"""Tables, fact files and batch scripts as messages."""
