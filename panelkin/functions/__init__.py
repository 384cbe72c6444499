"""Part of panelkin; see the README for the map of modules."""
