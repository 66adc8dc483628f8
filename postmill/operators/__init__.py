"""Operators over mails: parts, messages, attachments, notes."""
