"""Column to Column helpers. All are built-in expressions and stay inside whole-stage codegen."""
