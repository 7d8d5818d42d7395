"""Part of loomgraph; see the package README section."""
