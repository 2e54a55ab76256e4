"""Circuit-netlist and training-data analytics on PySpark DataFrames."""
