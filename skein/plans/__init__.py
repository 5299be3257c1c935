"""Composed plans: adapter views, registered queries, preparation, experiments."""
