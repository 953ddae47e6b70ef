"""Operators for preparing training and evaluation data of language models."""
