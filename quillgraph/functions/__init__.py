"""Part of quillgraph; see the README for the layout."""
