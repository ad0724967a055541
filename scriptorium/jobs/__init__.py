"""Thin spark-submit jobs: python -m scriptorium.jobs.<name>."""
