"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it.  Each module holds one operator with a general interface;
``queries`` holds the thin registered queries and ``oracles`` their SQL.
"""
