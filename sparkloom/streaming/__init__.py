"""Operators whose state is kept between batches."""
