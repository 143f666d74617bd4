"""Training-data operators: one module per operator, thin queries in ``queries``.

Nothing outside this package imports it.  Each module has a general interface
(frames in, frames with real texts, spans or pairs out); ``queries`` derives the
digest columns of the registered ``opN_*`` queries from them.
"""
