"""Named queries over the driver's tables, each with an equivalent SQL text where there is one."""
