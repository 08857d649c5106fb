"""Training-data operators: each module is one operator with its own general interface.

Nothing outside this folder imports it; ``queries`` holds the registered query of each operator.
"""
