"""Table-driven parsers for the source languages, built from bundled grammars."""
