"""Curation, splitting, sampling and scoring of instruction and multiple-choice corpora on Spark."""
