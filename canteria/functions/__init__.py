"""Part of the canteria package; see the README for the map."""
