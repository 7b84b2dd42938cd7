"""Whole jobs put together from functions and operators."""
