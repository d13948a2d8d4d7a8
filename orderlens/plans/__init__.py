"""The analyses: one function per query key, taking a lazy ``Model``."""
