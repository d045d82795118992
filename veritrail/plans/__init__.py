"""Whole jobs: feeds to facts, facts to a scored and aligned graph, questions to context."""
