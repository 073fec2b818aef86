"""Filing trees, company dimensions and chunk collections."""
