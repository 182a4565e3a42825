"""Operations on training text: near copies, benchmark leaks, personal data, secrets, mixing and the like.

Nothing outside this subpackage imports it; its queries are registered by ``__spark_entry__`` when it is there.
"""
