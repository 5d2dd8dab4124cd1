"""Training-data operators (quality, mixing, near duplicates, extraction, ...).

Nothing else in the library imports this subpackage.  Each operator module
exposes a general function; :mod:`causaloom.llm.entries` derives the registered
``opN_*`` queries from them.
"""
