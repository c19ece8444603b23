"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Every module holds one operator
and its thin ``query`` wrapper; :mod:`lumenweft.llm.registry` lists them.
"""
