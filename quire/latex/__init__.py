"""LaTeX sources: lexer, checks and idempotent rewrite passes, applied as Arrow-batched functions."""
