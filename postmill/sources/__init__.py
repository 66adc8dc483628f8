"""Where mails come from, and where notes and files go."""
