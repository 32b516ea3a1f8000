"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Ship the package to a cluster with
``--py-files`` (the tasks import :mod:`rulespan.llm` by name).
"""
