"""Operators for preparing language-model training data.

Nothing outside this folder imports it. Each module holds one operator with a general
interface; ``queries`` holds the thin registered queries built on them.
"""
