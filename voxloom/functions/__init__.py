"""Part of voxloom; see the README for the layout."""
