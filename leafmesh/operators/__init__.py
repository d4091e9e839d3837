"""Part of leafmesh; see the modules."""
