"""Evidence analytics as DataFrame operators.

Every operator is a function from DataFrames to a DataFrame; nothing is executed until the caller asks for rows, except
where an iterative operator has to look at one number to know whether it is finished.
"""
