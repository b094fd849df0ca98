"""Texts that several tests use."""

BODY = " ".join(f"word{i % 37} turn{i % 11} item{i}" for i in range(120))
OTHER = " ".join(f"quite{i} another{i % 23} text{i % 7}" for i in range(90))
