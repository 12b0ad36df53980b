"""Plan builders that the operators share."""
