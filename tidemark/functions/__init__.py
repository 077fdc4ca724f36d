"""Functions of the engine; see the modules."""
