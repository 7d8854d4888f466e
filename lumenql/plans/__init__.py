"""Named query plans over the star schema, each with its SQL counterpart."""
