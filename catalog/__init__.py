"""Every operator as a query over the driver tables, and the same queries as SQL."""
