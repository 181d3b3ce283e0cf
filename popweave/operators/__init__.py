"""Graph, population, simulation and analysis operators (DataFrame to DataFrame)."""
