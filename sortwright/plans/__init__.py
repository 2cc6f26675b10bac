"""Plans, moves, journals and questions."""
