"""Phonotactic analytics on Spark: lexicons, natural classes, constraint candidates, violations, grammars."""
