"""Whole jobs: staging, model inputs, parameter grid."""
