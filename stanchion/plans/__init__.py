"""Named queries over the driver tables, and the carriers that give each operator real input."""
