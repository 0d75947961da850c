"""Graph, policy and size operators over DataFrames."""
