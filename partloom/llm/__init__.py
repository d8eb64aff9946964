"""Training-data operators: one module per operator, each with a general interface and the thin
``opN_<name>`` query derived from it.  Nothing outside this subpackage imports it except ``__spark_entry__``,
which does so behind a guard."""
