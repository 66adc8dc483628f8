"""Mails that arrive while the engine runs: an extension."""
