"""The operators put together over the test tables."""
