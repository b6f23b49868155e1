"""Part of tessella; see the modules of this folder."""
