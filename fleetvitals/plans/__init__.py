"""Reports and the operators' bindings to the driver's tables."""
