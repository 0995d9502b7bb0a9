"""Tables on disk, markdown files and embedding connectors."""
