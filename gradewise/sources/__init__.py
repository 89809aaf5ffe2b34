"""Tables, SQL templates, metadata and synthetic books."""
