"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  ``loomline.llm.queries``
holds the registered queries and their oracle SQL.
"""
