"""Operators of a training-data pipeline (decontamination, archives, near-duplicates, language,
licences, repeated passages, quality, chat formatting, mixing).  Nothing else imports this package."""
