"""Training-data operators.

One module for each operator; :mod:`chronofold.llm.queries` registers them.
Nothing outside this subpackage imports it.
"""
