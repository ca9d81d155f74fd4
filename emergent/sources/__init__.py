"""Tables, stores, files and servers that data comes from and goes to."""
