"""The registered queries of the tools and operators, each with the SQL it is checked against."""
