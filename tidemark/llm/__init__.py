"""Training-data operators: ten corpus operators and the queries over them.

Nothing outside this folder imports it.  Each module holds one operator with
its general interface; ``queries`` derives the thin ``opN_*`` results from them.
"""
