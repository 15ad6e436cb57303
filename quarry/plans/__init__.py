"""Business questions: the catalogue over the driver tables (`catalogue`, with
independent SQL in `oracle`) and the four case studies on their seed data
(`restaurant`, `delivery`, `music`, `movies`)."""
