"""Functions of the engine; every function takes and returns DataFrames or Columns."""
