"""framelake: raster, signal, provenance and project analytics over table-shaped media corpora."""

__version__ = "0.1.0"
