"""DataFrame operators: DataFrame in, lazy DataFrame out unless the docstring says otherwise."""
