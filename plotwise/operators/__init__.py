"""DataFrame-to-DataFrame operators. None of them triggers an action."""
