"""Model training and batch scoring on MLlib."""
