"""Operators for preparing training text: each module is one operator on DataFrames.

``queries`` registers the ``opN_<name>`` queries; nothing else in the library imports this package.
"""
