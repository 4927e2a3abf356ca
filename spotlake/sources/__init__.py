"""Where lines come from and where events go."""
